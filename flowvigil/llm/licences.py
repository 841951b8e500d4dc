"""Licence scans with a generalised suffix automaton of licence tokens.

The automaton holds every run of words of all templates. A text is streamed through it word
by word, which gives the matching statistics: at each word the length of the longest run that
ends here and stands in some template. Long matches are chained into spans of the template
they cover. Words that stand in no template reset the automaton, so only runs of template words
are stepped through, found for all words of a block by their hashes.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flowvigil.llm.tasks import map_blocks
from flowvigil.llm.text import Texts, lut, word_hashes, words

# Letters, digits and all characters outside ASCII; A-Z are lower case by then.
LICENCE_WORD = lut((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))

# Phrases that are counted, and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Notices of public licences.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser "
             "general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
)
LEAST = 5       # words of a match that counts for a span
GAP = 3         # words between matches of one span
COVER = 0.5     # share of a template that gives its label


class Automaton:
    """Generalised suffix automaton over the words of ``texts`` (label, words)."""

    def __init__(self, texts: list[tuple[str, list[str]]], phrases: list[tuple[str, list[str]]]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.owners: list[set[int]] = [set()]
        for number, (_, run) in enumerate([*texts, *phrases]):
            last = 0
            for word in run:
                last = self._extend(last, word)
            state = 0
            for word in run:  # every prefix, and by the links every run, belongs to this text
                state = self.next[state][word]
                up = state
                while up > 0 and number not in self.owners[up]:
                    self.owners[up].add(number)
                    up = self.link[up]
        # phrases that end where a match in this state ends, with their number of words
        self.phrases: list[list[tuple[int, str]]] = [[] for _ in self.next]
        for label, run in phrases:
            state = 0
            for word in run:
                state = self.next[state][word]
            self.phrases[state].append((len(run), label))
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.phrases[state] = self.phrases[state] + self.phrases[self.link[state]]
        self.templates = len(texts)
        self.words = sorted({w for _, run in [*texts, *phrases] for w in run})

    def _state(self, length: int, link: int, after: dict[str, int]) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        self.owners.append(set())
        return len(self.next) - 1

    def _extend(self, last: int, word: str) -> int:
        if word in self.next[last]:  # an earlier text has this run
            there = self.next[last][word]
            return there if self.length[there] == self.length[last] + 1 else self._copy(last, word, there)
        new, at = self._state(self.length[last] + 1, 0, {}), last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            there = self.next[at][word]
            self.link[new] = there if self.length[there] == self.length[at] + 1 else self._copy(at, word, there)
        return new

    def _copy(self, at: int, word: str, there: int) -> int:
        copy = self._state(self.length[at] + 1, self.link[there], dict(self.next[there]))
        self.owners[copy] = set(self.owners[there])
        self.link[there] = copy
        while at >= 0 and self.next[at].get(word) == there:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def statistics(self, run: list[str]) -> list[tuple[int, int]]:
        """For each word the length of the longest match that ends with it, and its state."""
        out, state, size = [], 0, 0
        for word in run:
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.next[state]:
                state, size = self.next[state][word], size + 1
            out.append((size, state))
        return out


@functools.lru_cache(4)
def automaton(templates=TEMPLATES, phrases=PHRASES) -> tuple[Automaton, np.ndarray, list[str]]:
    """The automaton, and its words in the order of their hashes."""
    made = Automaton([(n, t.split()) for n, t in templates], [(label, p.split()) for p, label in phrases])
    texts = Texts(pa.array(made.words))
    hashes = word_hashes(texts, texts.off[:-1], texts.off[1:])
    order = np.argsort(hashes)
    return made, hashes[order], [made.words[i] for i in order]


def chain(matches: list[tuple[int, int]], gap: int) -> list[tuple[int, int, int]]:
    """Matches (start, end) by start, chained over gaps: (start, end, words covered)."""
    out: list[list[int]] = []
    for start, end in matches:
        if out and start - out[-1][1] <= gap:
            out[-1][2] += max(0, end - max(start, out[-1][1]))
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end, end - start])
    return [tuple(x) for x in out]


def scan(made: Automaton, run: list[str], at: int):
    """Phrase places and template matches of one run of template words that starts at word ``at``."""
    places, matches = [], []
    stats = made.statistics(run)
    for i, (size, state) in enumerate(stats):
        for length, label in made.phrases[state]:
            if length <= size:
                places.append((at + i - length + 1, label))
        if size >= LEAST and (i + 1 == len(stats) or stats[i + 1][0] <= size):
            for owner in made.owners[state]:
                if owner < made.templates:
                    matches.append((owner, at + i - size + 1, at + i + 1))
    return places, matches


SCHEMA = ("doc_id long, n_words long, places array<struct<word:int,label:string>>, "
          "spans array<struct<label:string,start:int,end:int,covered:int>>, score double")


def scan_licences(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """For each row: doc_id, n_words, ``places`` of the phrases, ``spans`` of templates (in words) and ``score``.

    The score is the largest share of a template that one span covers, 0 to 1. A null or empty
    text has no words and score 0; rows with the same doc_id are looked at each on its own;
    other columns are not looked at.
    """
    def run(block):
        made, hashes, vocabulary = automaton(templates, phrases)
        sizes = [(n, len(t.split())) for n, t in templates]
        shortest = min([LEAST, *(len(p.split()) for p, _ in phrases)])
        texts = Texts(block["text"]).lowered()
        starts, ends, off = words(texts, LICENCE_WORD)
        h = word_hashes(texts, starts, ends)
        number = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        known = hashes[number] == h
        places, spans, scores = ([[] for _ in range(len(texts))] for _ in range(3))
        edge = np.zeros(len(h) + 1, bool)
        edge[off] = True
        begin = np.flatnonzero(known & (edge[:-1] | ~np.concatenate([[False], known[:-1]])))
        stop = np.flatnonzero(known & (edge[1:] | ~np.concatenate([known[1:], [False]]))) + 1
        long = stop - begin >= shortest
        begin, stop = begin[long], stop[long]
        doc = np.searchsorted(off, begin, "right") - 1
        found: dict[tuple[int, int], list] = {}
        for a, b, d in zip(begin.tolist(), stop.tolist(), doc.tolist()):
            p, m = scan(made, [vocabulary[i] for i in number[a:b]], a - int(off[d]))
            places[d] += p
            for owner, s, e in m:
                found.setdefault((d, owner), []).append((s, e))
        for (d, owner), matches in sorted(found.items()):
            label, size = sizes[owner]
            for s, e, covered in chain(sorted(matches), GAP):
                spans[d].append({"label": label, "start": s, "end": e, "covered": covered})
                scores[d].append(min(1.0, covered / size))
        kinds = (pa.list_(pa.struct([("word", pa.int32()), ("label", pa.string())])),
                 pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("covered", pa.int32())])))
        return pa.table({"doc_id": block["doc_id"], "n_words": pa.array(np.diff(off), pa.int64()),
                         "places": pa.array([[{"word": w, "label": x} for w, x in sorted(set(p))] for p in places], kinds[0]),
                         "spans": pa.array(spans, kinds[1]), "score": pa.array([max(x, default=0.0) for x in scores], pa.float64())})
    return map_blocks(docs.select("doc_id", "text"), run, SCHEMA)
