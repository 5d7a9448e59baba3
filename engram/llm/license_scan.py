"""Licence scan: phrases, and spans of licence templates found by a generalised suffix automaton of their words.

The automaton accepts every run of words of every template, so reading a text through it gives, at each word, the longest
run ending there that some template holds (the matching statistics). Runs of `LONG` words or more are kept at the place
where they can't go on. Runs of one template that follow each other within `GAP` words in the text, at rising places of the
template, are chained to a span; a template whose spans cover `SHARE` of its words in one chain gives its label.

The automaton is as large as the templates, whatever the corpus; texts are read where they are and nothing is shuffled.
A word that no template has resets the automaton, so only stretches of template words are read word by word.

Null and empty texts have no words. Rows without an id and repeated rows are scanned like others. An empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import ALNUM, Words, as_bytes, map_slices

LONG, GAP, SHARE = 4, 30, 0.5

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Well-known notices of public licences, with their labels.
TEMPLATES = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software."""),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at"""),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
        later version."""),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
        General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your
        option) any later version."""),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at"""),
    ("cc-by", """This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this
        license, visit"""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means."""),
]


class Automaton:
    """Generalised suffix automaton over word numbers; each state knows where its runs end in the templates."""

    def __init__(self, texts: list[list[int]]):
        self.next, self.link, self.size = [{}], [-1], [0]
        self.ends: list[dict[int, int]] = [{}]  # template: the first place after a run's last word
        for t, words in enumerate(texts):
            last = 0
            for at, w in enumerate(words):
                last = self._extend(last, w)
                self.ends[last].setdefault(t, at + 1)
        for s in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            above = self.ends[self.link[s]]
            for t, at in self.ends[s].items():
                above[t] = min(at, above.get(t, at))

    def _state(self, size: int, after: dict, link: int) -> int:
        self.next.append(after)
        self.link.append(link)
        self.size.append(size)
        self.ends.append({})
        return len(self.size) - 1

    def _split(self, p: int, w: int) -> int:
        """The state of the run that p reaches by w, of p's size and one more."""
        q = self.next[p][w]
        if self.size[q] == self.size[p] + 1:
            return q
        part = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = part
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = part
            p = self.link[p]
        return part

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w)
        new, p = self._state(self.size[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w)
        return new

    def runs(self, words: list[int], least: int) -> list[tuple[int, int, dict[int, int]]]:
        """(first place, number of words, ends by template) of the runs that can't go on, of `least` words or more."""
        out, state, size = [], 0, 0
        for at, w in enumerate(words):
            if w not in self.next[state]:
                if size >= least:
                    out.append((at - size, size, self.ends[state]))
                while state and w not in self.next[state]:
                    state = self.link[state]
                    size = self.size[state]
            if w in self.next[state]:
                state, size = self.next[state][w], size + 1
            else:
                state, size = 0, 0
        if size >= least:
            out.append((len(words) - size, size, self.ends[state]))
        return out


def tokens(text: bytes) -> list[bytes]:
    return text.translate(ALNUM).split()


@cache
def _library() -> tuple[dict[bytes, int], Automaton, list[str], list[int]]:
    """Numbers of template words (from 1), the automaton, and label and size of each template."""
    split = [tokens(t.encode()) for _, t in TEMPLATES]
    numbers: dict[bytes, int] = {}
    for words in split:
        for w in words:
            numbers.setdefault(w, len(numbers) + 1)
    for phrase in PHRASES:
        for w in phrase.encode().split():
            numbers.setdefault(w, len(numbers) + 1)
    return numbers, Automaton([[numbers[w] for w in words] for words in split]), [label for label, _ in TEMPLATES], list(map(len, split))


def spans(words: np.ndarray) -> list[tuple[str, int, int, float]]:
    """(label, first word, word after the last, covered share of the template) of each chain of runs."""
    _, automaton, labels, sizes = _library()
    known = np.concatenate([[False], words > 0, [False]])
    edges = np.flatnonzero(known[1:] != known[:-1])
    found: dict[int, list[tuple[int, int, int]]] = {}
    for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if e - s >= LONG:
            for at, size, ends in automaton.runs(words[s:e].tolist(), LONG):
                for t, end in ends.items():
                    found.setdefault(t, []).append((s + at, size, end))
    out = []
    for t, runs in found.items():
        first, text_end, end, covered = -1, 0, 0, 0
        for at, size, place in runs:
            if covered and at - text_end <= GAP and place > end:
                new = min(size, place - end, at + size - text_end)  # without what the chain has already
            else:
                if covered:
                    out.append((labels[t], first, text_end, covered / sizes[t]))
                first, covered, new = at, 0, size
            covered, text_end, end = covered + new, max(text_end, at + size) if covered else at + size, place
        out.append((labels[t], first, text_end, covered / sizes[t]))
    return out


def phrases(words: np.ndarray) -> list[tuple[str, np.ndarray, int]]:
    """(label, first words of its places, words) of each phrase that stands in the text."""
    numbers, out = _library()[0], []
    for phrase, label in PHRASES.items():
        want = [numbers[w] for w in phrase.encode().split()]
        if len(words) >= len(want):
            at = np.flatnonzero(np.logical_and.reduce([words[k : len(words) - len(want) + 1 + k] == w for k, w in enumerate(want)]))
            if len(at):
                out.append((label, at, len(want)))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""

    def run(batches):
        numbers = _library()[0]
        book = Words(lambda w: numbers.get(w, 0))
        for b in batches:
            split = [tokens(t) if t else [] for t in as_bytes(b.column("text"))]
            flat, at, out = book.values([w for ws in split for w in ws]).astype(np.int64), 0, []
            for ws in split:
                words = flat[at : at + len(ws)]
                at += len(ws)
                base = phrases(words)
                starts = np.concatenate([p for _, p, _ in base]) if base else None
                chains = spans(words)
                good = {label for label, _, _, share in chains if share >= SHARE}
                own = {label for label, _, _ in base}
                out.append((
                    len(ws), 0 if starts is None else len(starts), None if starts is None else int(starts.min()), None if starts is None else int(starts.max()),
                    ",".join(sorted(own)), ",".join(sorted(own | good)), max((min(share, 1.0) for *_, share in chains), default=1.0 if own else 0.0),
                    [{"label": label, "first": s, "last": e - 1, "share": share} for label, s, e, share in sorted(chains, key=lambda x: (x[1], x[0]))],
                ))
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True))], names=_NAMES)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_slices(rows, run, "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label string, first bigint, last bigint, share double>>")


_SPAN = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())])
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(_SPAN))
_NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
