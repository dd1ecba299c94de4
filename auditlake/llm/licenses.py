"""License scan: matching statistics against license wording, chained into covered template spans.

The wording of all templates is indexed in one generalised suffix automaton over tokens. A document's words stream
through it once; after each word the automaton knows the longest run of words ending there that stands in some
template. Runs that cannot grow are long matches; those of one template that follow each other, in the text as in
the template and at small distance, are chained into a span, and a span that covers enough of its template labels
the document. Base phrases are templates too: a phrase ends at a word exactly when its state is on the suffix-link
path of the word's state.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame

from auditlake.llm.common import by_rows, documents_of

# Phrases that label a text by themselves.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Public license notices, as the licenses ask for them to be given.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "mit": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ],
    "gpl-3.0": [
        "licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version.",
    ],
    "gpl-2.0": [
        "licensed under the GNU General Public License, version 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation; either version 2 of the License, or "
        "(at your option) any later version.",
    ],
    "bsd-3-clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met",
    ],
    "cc-by-4.0": [
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ],
    "cc-by-nc-4.0": [
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ],
    "cc-by-sa-4.0": [
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "all-rights-reserved": ["All rights reserved"],
}

MIN_MATCH = 3  # words of a match that a chain may use, or the whole template if that is shorter
MAX_GAP = 8  # words between two matches of a chain, in the text and in the template
MIN_COVERAGE = 0.75  # share of a template's words that its span must cover

# Words are runs of ASCII letters and digits and of anything outside ASCII; A-Z are lowered.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class Automaton:
    """Generalised suffix automaton of token sequences, with what a scan needs to know of each state."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        # First end position of the state's strings in each sequence that holds them.
        self.ends: list[dict[int, int]] = [{}]
        for number, tokens in enumerate(sequences):
            last = 0
            for position, token in enumerate(tokens):
                last = self._extend(last, token)
                self.ends[last].setdefault(number, position)
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            for number, position in self.ends[state].items():
                above = self.ends[self.link[state]]
                above[number] = min(above.get(number, position), position)
        self.ends[0] = {}

    def _new(self, length: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, state: int, token: int) -> int:
        """The state for `state`'s longest string followed by the token, made anew if longer strings share it."""
        target = self.next[state][token]
        if self.length[target] == self.length[state] + 1:
            return target
        twin = self._new(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = twin
        while state != -1 and self.next[state].get(token) == target:
            self.next[state][token] = twin
            state = self.link[state]
        return twin

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            return self._split(last, token)
        added = self._new(self.length[last] + 1, {}, 0)
        while last != -1 and token not in self.next[last]:
            self.next[last][token] = added
            last = self.link[last]
        if last != -1:
            self.link[added] = self._split(last, token)
        return added

    def state_of(self, tokens: Iterable[int]) -> int:
        state = 0
        for token in tokens:
            state = self.next[state][token]
        return state


class Scanner:
    """Scan of one text at a time; built once per task from the templates."""

    def __init__(self, templates: dict[str, list[str]], phrases: dict[str, str], min_match: int, max_gap: int, min_coverage: float):
        self.min_match, self.max_gap, self.min_coverage = min_match, max_gap, min_coverage
        self.names, sequences = [], []
        self.ids: dict[bytes, int] = {}
        for label in sorted(templates):
            for wording in templates[label]:
                self.names.append(label)
                sequences.append(self._tokens(wording))
        self.sizes = [len(s) for s in sequences]
        phrase_tokens = [(self._tokens(p), label) for p, label in phrases.items()]
        self.automaton = Automaton(sequences + [t for t, _ in phrase_tokens])
        # For each state the phrases that end its longest string, as (words, label).
        ending: dict[int, list[tuple[int, str]]] = {}
        for tokens, label in phrase_tokens:
            ending.setdefault(self.automaton.state_of(tokens), []).append((len(tokens), label))
        self.phrases: list[list[tuple[int, str]]] = [[]]
        for state in range(1, len(self.automaton.next)):
            found, at = [], state
            while at > 0:
                found += ending.get(at, [])
                at = self.automaton.link[at]
            self.phrases.append(found)

    def _tokens(self, wording: str) -> list[int]:
        return [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(wording)]

    def scan(self, text: str):
        """(words, base hits as (start, label), spans as (label, start, end, coverage))."""
        follow, link, length = self.automaton.next, self.automaton.link, self.automaton.length
        phrases, known = self.phrases, self.ids
        words = words_of(text)
        tokens = [known.get(w, 0) for w in words]
        base: list[tuple[int, str]] = []
        matches: dict[int, list[tuple[int, int, int]]] = {}
        state = run = 0
        for i, token in enumerate(tokens):
            if not token:
                if run:
                    self._match(matches, i - run, run, state)
                    state = run = 0
                continue
            if token in follow[state]:
                state = follow[state][token]
                run += 1
            else:
                self._match(matches, i - run, run, state)
                while state > 0 and token not in follow[state]:
                    state = link[state]
                    run = length[state]
                state = follow[state].get(token, 0)
                run = run + 1 if state else 0
            for size, label in phrases[state]:
                if run >= size:
                    base.append((i + 1 - size, label))
        if run:
            self._match(matches, len(tokens) - run, run, state)
        return len(words), base, self._spans(matches)

    def _match(self, matches, start: int, run: int, state: int) -> None:
        for number, end in self.automaton.ends[state].items():
            if number < len(self.sizes) and run >= min(self.min_match, self.sizes[number]):
                matches.setdefault(number, []).append((start, end + 1 - run, run))

    def _spans(self, matches) -> list[tuple[str, int, int, float]]:
        """Chains of matches that advance in text and template, as covered spans."""
        spans = []
        for number, found in matches.items():
            size, best = self.sizes[number], []
            for start, at, run in found:
                covered, begin = run, start
                for other_end, other_at, other_covered, other_begin in reversed(best):
                    if start - other_end > self.max_gap + size:
                        break
                    # Words that both matches hold count once.
                    shared = max(0, other_end - start, other_at - at)
                    if shared < run and start - other_end <= self.max_gap and at - other_at <= self.max_gap and at + run > other_at:
                        if other_covered + run - shared > covered:
                            covered, begin = other_covered + run - shared, other_begin
                best.append((start + run, at + run, covered, begin))
            for end, _, covered, begin in best:
                if covered >= self.min_coverage * size:
                    spans.append((self.names[number], begin, end, min(1.0, covered / size)))
        return spans


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, list[str]] | None = None,
    phrases: dict[str, str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_match: int = MIN_MATCH,
    max_gap: int = MAX_GAP,
    min_coverage: float = MIN_COVERAGE,
) -> DataFrame:
    """One row per input row: doc_id, n_words, base (start, label), spans (label, start, end, coverage), score.

    `base` lists every place where a base phrase's words stand consecutively, `spans` the chains that cover at
    least `min_coverage` of a template. The score is the best coverage, 1 where a base phrase stands. Null and
    empty texts have no words and score 0; null ids and repeated rows stay, each with its own row; other columns
    are not read. The whole of each text is scanned; memory is bounded by the longest text.
    """
    templates = TEMPLATES if templates is None else templates
    phrases = BASE_PHRASES if phrases is None else phrases
    ddl = (
        "doc_id long, n_words long, base array<struct<start: long, label: string>>, "
        "spans array<struct<label: string, start: long, end: long, coverage: double>>, score double"
    )

    def make():
        scanner = Scanner(templates, phrases, min_match, max_gap, min_coverage)

        def step(rows):
            out = {"doc_id": rows["doc_id"], "n_words": [], "base": [], "spans": [], "score": []}
            for text in rows["text"]:
                n, base, spans = scanner.scan(text)
                out["n_words"].append(n)
                out["base"].append([{"start": s, "label": label} for s, label in base])
                out["spans"].append([dict(zip(("label", "start", "end", "coverage"), s)) for s in spans])
                out["score"].append(1.0 if base else max((s[3] for s in spans), default=0.0))
            return out

        return step

    return by_rows(documents_of(docs, id_col, text_col), ddl, make)


def brute_force(text: str, phrases: dict[str, str] = BASE_PHRASES) -> list[tuple[int, str]]:
    """Base hits by comparing every place of a text, for tests."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return sorted(
        (i, label)
        for phrase, label in phrases.items()
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    )
