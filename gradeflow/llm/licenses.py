"""License scan: a suffix automaton over the words of license texts, and chains of long matches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_table, flat_bytes, plain, small_blocks, word_bounds, word_hashes

# Phrases whose places are counted, and the label of each.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# The opening words of well-known license texts, by label.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and "
           "associated documentation files the software to deal in the software without restriction including "
           "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
           "copies of the software",
    "apache": "licensed under the apache license version 2 0 the license you may not use this file except in "
              "compliance with the license you may obtain a copy of the license at",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu "
           "general public license as published by the free software foundation either version 2 of the license "
           "or at your option any later version",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided "
           "that the following conditions are met",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is "
           "hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl "
           "was not distributed with this file you can obtain one at",
}
LONG_MATCH = 5      # words; shorter matches do not enter a chain
GAP = 8             # words between the members of a chain
COVERAGE = 0.3      # part of a template that a chain covers for its label


@dataclass
class Automaton:
    """States of the generalised suffix automaton of several word sequences."""

    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[dict[int, int]] = field(default_factory=lambda: [{}])  # template -> where it was last seen to end

    def _state(self, step: dict[int, int], link: int, length: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.ends.append({})
        return len(self.step) - 1

    def _split(self, p: int, word: int) -> int:
        q = self.step[p][word]
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._state(dict(self.step[q]), self.link[q], self.length[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[int], template: int) -> None:
        last = 0
        path = []
        for word in words:
            if word in self.step[last]:
                last = self._split(last, word)
            else:
                new, p = self._state({}, 0, self.length[last] + 1), last
                while p >= 0 and word not in self.step[p]:
                    self.step[p][word] = new
                    p = self.link[p]
                self.link[new] = 0 if p < 0 else self._split(p, word)
                last = new
            path.append(last)
        state = 0
        for at, word in enumerate(words):  # every suffix that ends here is seen at this place
            state = self.step[state][word]
            up = state
            while up > 0:
                self.ends[up].setdefault(template, at)
                up = self.link[up]

    def statistics(self, words: Iterable[int]) -> Iterator[tuple[int, int]]:
        """For each word, the state and length of the longest match that ends there."""
        state = size = 0
        for word in words:
            while state and word not in self.step[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.step[state]:
                state, size = self.step[state][word], size + 1
            yield state, size


def hashed(text: str) -> np.ndarray:
    buf, offsets = flat_bytes(pa.array([text]))
    starts, ends, _ = word_bounds(buf, offsets, "nonword")
    return word_hashes(buf, starts, ends)


class Scanner:
    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        self.labels = list(templates)
        self.phrases = list(phrases.items())
        sequences = [hashed(t) for t in [*templates.values(), *phrases]]
        self.vocabulary = np.unique(np.concatenate(sequences))
        coded = [np.searchsorted(self.vocabulary, s).tolist() for s in sequences]
        self.lengths = [len(c) for c in coded]
        self.automaton = Automaton()
        for i, words in enumerate(coded):
            self.automaton.add(words, i)
        # The phrases that end in each state: those of the states on its chain of suffixes.
        own: dict[int, list[int]] = {}
        for p, words in enumerate(coded[len(templates):]):
            state = 0
            for w in words:
                state = self.automaton.step[state][w]
            own.setdefault(state, []).append(p)
        self.phrase_words = [len(c) for c in coded[len(templates):]]
        self.holds: list[list[int]] = []
        for state in range(len(self.automaton.step)):
            held, up = [], state
            while up > 0:
                held += own.get(up, [])
                up = self.automaton.link[up]
            self.holds.append(held)

    def scan(self, codes: np.ndarray):
        """Places of phrases (phrase, start) and covered spans (template, start, end, covered)."""
        places: list[tuple[int, int]] = []
        matches: dict[int, list[tuple[int, int, int]]] = {}
        known = codes >= 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)))
        for lo, hi in edge.reshape(-1, 2).tolist():
            if hi - lo < 2:  # a single known word between unknown ones is no phrase and no long match
                continue
            found = list(self.automaton.statistics(codes[lo:hi].tolist()))
            for k, (state, size) in enumerate(found):
                for p in self.holds[state]:
                    if size >= self.phrase_words[p]:
                        places.append((p, lo + k - self.phrase_words[p] + 1))
                if size >= LONG_MATCH and (k + 1 == len(found) or found[k + 1][1] <= size):
                    for t, end in self.automaton.ends[state].items():
                        if t < len(self.labels):
                            matches.setdefault(t, []).append((lo + k - size + 1, lo + k + 1, end - size + 1))
        spans = [span for t, found in matches.items() for span in self.chain(t, found)]
        return places, spans

    def chain(self, template: int, matches: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, float]]:
        """Chains of matches, in the order of the text and of the template, with small gaps."""
        held: list[tuple[int, int, int]] = []

        def span():
            covered: set[int] = set()
            for a, b, at in held:
                covered.update(range(at, at + b - a))
            return template, held[0][0], held[-1][1], len(covered) / self.lengths[template]

        for match in sorted(matches):
            if held and (match[0] > held[-1][1] + GAP or match[2] < held[-1][2]):
                yield span()
                held = []
            held.append(match)
        if held:
            yield span()


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None,
                  coverage: float = COVERAGE, spans: bool = True) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and, if ``spans``,
    ``spans`` (label, start, end, coverage).

    Words are runs of ASCII letters and digits and of all that is not ASCII, A-Z lower-cased.
    ``n_base`` counts all places of the phrases; ``labels`` adds the templates of which a chain
    covers at least ``coverage``; ``score`` is 1 where a phrase stands, else the best coverage.
    One row per row of ``docs``, in one pass without a shuffle; null text is empty text: zero
    counts, null places, empty labels, score 0.
    """
    scanner = Scanner(TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in small_blocks(batches):
            buf, offsets = flat_bytes(block.column("text"))
            buf = byte_table("lower")[buf]
            starts, ends, firsts = word_bounds(buf, offsets, "nonword")
            values = word_hashes(buf, starts, ends)
            codes = np.minimum(np.searchsorted(scanner.vocabulary, values), len(scanner.vocabulary) - 1)
            codes = np.where(scanner.vocabulary[codes] == values, codes, -1)
            rows = []
            for lo, hi in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
                places, found = scanner.scan(codes[lo:hi])
                at = [start for _, start in places]
                base = {scanner.phrases[p][1] for p, _ in places}
                more = {scanner.labels[t] for t, _, _, part in found if part >= coverage}
                best = max([part for *_, part in found], default=0.0)
                rows.append((hi - lo, len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)),
                             ",".join(sorted(base | more)), 1.0 if places else float(best),
                             [{"label": scanner.labels[t], "start": a, "end": b, "coverage": part}
                              for t, a, b, part in found]))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types)]], names)

    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    schema = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
              "labels string, score double")
    if spans:
        names, schema = names + ["spans"], schema + ", spans array<struct<label: string, start: long, end: long, coverage: double>>"
        types.append(pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                         ("coverage", pa.float64())])))
    return plain(docs, id_col, text_col).mapInArrow(run, schema)
