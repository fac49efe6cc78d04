"""Licence scan: phrases, and templates with optional and replaceable regions.

A template is written in words with ``[[ ... ]]`` around what may be left out and ``<<n>>``
where up to n words may stand. It is compiled to an automaton over words; a place is
accepted if all wording outside such regions is there, word by word. The automaton is started
only where the first mandatory words of the template are found, and takes the longest match.

Edge cases. A null text is read as empty. Overlapping places all count. Repeated rows are
scanned each. Texts of any length take time in proportion to their length and to the number
of starts times the length of a template.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
TEMPLATES = (
    ("apache-2.0", "[[this work is]] licensed under the apache license [[version]] 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file "
                   "except in compliance with the license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
            "provided that the following conditions are met"),
    ("cc-by-nc-4.0", "licensed under [[a]] [[the]] cc by nc 4 0"),
    ("cc-by-4.0", "licensed under [[a]] [[the]] creative commons attribution 4 0 international license"),
    ("gpl-3.0", "licensed under the gnu general public license [[as published by the free software foundation]] "
                "[[either]] version 3 [[of the license]]"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
            "general public license as published by the free software foundation [[either]] version <<3>> of the "
            "license [[or at your option any later version]]"),
    ("copyright", "copyright [[c]] <<8>> all rights reserved"),
)

# ASCII A-Z to lower case, other ASCII but digits and letters to a space; bytes from 128 on stay.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
               for c in range(256))


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Automaton:
    """States in a row; each has the words that lead to the next and jumps without a word."""

    def __init__(self, template: str):
        self.word: list[bytes | None] = []      # word of the step from state i to i + 1
        self.jumps: dict[int, set[int]] = {}
        start: int | None = None
        for mark, gap, word in re.findall(r"(\[\[|\]\])|<<(\d+)>>|([^\s\[\]<>]+)", template):
            if mark == "[[":
                start = len(self.word)
            elif mark == "]]":
                self.jumps.setdefault(start, set()).add(len(self.word))
                start = None
            elif gap:
                first = len(self.word)
                self.word += [None] * int(gap)
                for i in range(first, first + int(gap)):
                    self.jumps.setdefault(i, set()).add(first + int(gap))
            else:
                self.word.append(word.encode())
        self.end = len(self.word)
        # The longest run of words that nothing jumps over, by which a text without a match is
        # passed, and the words with which a match can begin.
        free = [w is not None and not any(a <= i < b for a, bs in self.jumps.items() for b in bs)
                for i, w in enumerate(self.word)]
        runs, at = [], 0
        while at < self.end:
            if free[at]:
                to = at
                while to < self.end and free[to]:
                    to += 1
                runs.append((to - at, -at))
                at = to
            else:
                at += 1
        length, begin = max(runs)
        self.anchor = b" " + b" ".join(self.word[-begin:-begin + length]) + b" "
        self.firsts = {self.word[i] for i in self._closed({0}) if i < self.end}

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for to in self.jumps.get(todo.pop(), ()):
                if to not in states:
                    states.add(to)
                    todo.append(to)
        return states

    def match(self, words: list[bytes], at: int) -> int:
        """End of the longest match that starts at ``at``; -1 if there is none."""
        states, best = self._closed({0}), -1
        while True:
            if self.end in states:
                best = at
            if at >= len(words):
                return best
            word = words[at]
            states = self._closed({i + 1 for i in states if i < self.end
                                   and (self.word[i] is None or self.word[i] == word)})
            if not states:
                return best
            at += 1


class Scanner:
    def __init__(self, phrases=PHRASES, templates=TEMPLATES):
        self.phrases = [(b" " + p.encode() + b" ", len(p.split()), label) for p, label in phrases]
        self.templates = [(label, Automaton(t)) for label, t in templates]

    def scan(self, text: str):
        """``n_words, n_base, first_word, last_word, base labels, all labels, covered words``."""
        words = tokens(text)
        line = b" " + b" ".join(words) + b" "
        starts, base, covered = [], set(), []
        for phrase, size, label in self.phrases:
            at, place, upto = line.find(phrase), 0, 0
            while at >= 0:
                place += line.count(b" ", upto, at)
                upto = at
                starts.append(place)
                covered.append((place, place + size))
                base.add(label)
                at = line.find(phrase, at + 1)
        labels = set(base)
        for label, automaton in self.templates:
            if automaton.anchor not in line:
                continue
            place = 0
            while place < len(words):
                if words[place] in automaton.firsts or None in automaton.firsts:
                    end = automaton.match(words, place)
                    if end > place:
                        labels.add(label)
                        covered.append((place, end))
                place += 1
        total, upto = 0, 0
        for a, b in sorted(covered):
            total += max(0, b - max(a, upto))
            upto = max(upto, b)
        return (len(words), len(starts), min(starts, default=None), max(starts, default=None),
                ",".join(sorted(base)), ",".join(sorted(labels)), total / len(words) if words else 0.0)


FIELDS = (("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
          ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()))


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, doc_id: str = "doc_id",
         text: str = "text") -> DataFrame:
    """Places, labels and score of every document. The score is the part of its words that
    lies in accepted places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for batch in batches:
            found = [scanner.scan(t.as_py() or "") for t in batch.column(1)]
            columns = list(zip(*found)) if found else [[] for _ in FIELDS]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, kind) for c, (_, kind) in zip(columns, FIELDS)]],
                names=["doc_id", *[name for name, _ in FIELDS]])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, n_words long, n_base long, "
                                "first_word long, last_word long, base_labels string, labels string, score double")
