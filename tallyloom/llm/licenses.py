"""License scans: templates with optional and replaceable regions, compiled to automata over words.

Markup of a template: plain words are mandatory, `<<opt>> ... <<end>>` may be left out as a whole, and
`<<var:N>>` stands for up to N words of any kind. An automaton keeps the set of states it may be in
while it reads a text's words; it accepts where every mandatory word was met exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ALNUM, Hasher, Words, slices

#: Phrases whose places count, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_GNU = (
    "<<var:3>> is free software you can redistribute it and or modify it under the terms of the gnu {0}general public license as published by the free software foundation "
    "either version <<var:3>> of the license or at your option any later version <<var:3>> is distributed in the hope that it will be useful but without any warranty without even the implied "
    "warranty of merchantability or fitness for a particular purpose see the gnu {0}general public license for more details"
)

#: License notices and texts, by label.
TEMPLATES = [
    ("mit-notice", "<<opt>> released <<end>> <<opt>> licensed <<end>> <<opt>> distributed <<end>> under the mit license"),
    (
        "mit-grant",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<opt>> the software <<end>> "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
        "copies of the software <<opt>> and to permit persons to whom the software is furnished to do so <<end>>",
    ),
    (
        "mit-text",
        "<<opt>> <<opt>> the <<end>> mit license <<end>> <<opt>> copyright <<opt>> c <<end>> <<var:8>> <<end>> permission is hereby granted free of charge to any person obtaining a copy of this software "
        "and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute "
        "sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this "
        "permission notice <<opt>> including the next paragraph <<end>> shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any "
        "kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright "
        "holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other "
        "dealings in the software",
    ),
    (
        "isc-text",
        "permission to use copy modify and <<opt>> or <<end>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission "
        "notice appear in all copies the software is provided as is and <<var:6>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall <<var:6>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of "
        "contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    (
        "bsd-text",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<opt>> 1 <<end>> redistributions of source code must "
        "retain the above copyright notice this list of conditions and the following disclaimer <<opt>> 2 <<end>> redistributions in binary form must reproduce the above copyright notice this list of "
        "conditions and the following disclaimer in the documentation and or other materials provided with the distribution <<opt>> <<opt>> 3 <<end>> neither the name of <<var:10>> nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission <<end>> this software is provided by the copyright holders and "
        "contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event "
        "shall the copyright <<var:1>> or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of "
        "substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including "
        "negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    ),
    ("apache-2.0-notice", "licensed under <<opt>> the <<end>> apache license <<opt>> version <<end>> 2 0 <<opt>> the license <<end>>"),
    (
        "apache-2.0-header",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at <<var:1>> www apache org licenses "
        "license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind "
        "either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    *[(f"gpl-{v}.0-notice", f"<<opt>> under <<end>> <<opt>> the terms of <<end>> <<opt>> the <<end>> <<opt>> gnu <<end>> general public license <<opt>> as published by <<var:6>> either <<end>> version {v}") for v in (2, 3)],
    ("gpl-header", _GNU.format("")),
    ("lgpl-header", _GNU.format("lesser ")),
    ("agpl-header", _GNU.format("affero ")),
    ("mpl-2.0-header", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at <<var:2>> mozilla org mpl 2 0"),
    ("cc-by-nc-4.0-notice", "licensed under <<opt>> a <<end>> <<opt>> the <<end>> <<opt>> creative commons <<end>> cc by nc 4 0"),
    ("cc-notice", "licensed under <<opt>> a <<end>> <<opt>> the <<end>> creative commons attribution <<opt>> noncommercial <<end>> <<opt>> non commercial <<end>> <<opt>> sharealike <<end>> <<opt>> noderivatives <<end>> <<var:2>> <<opt>> international <<end>> license"),
    (
        "unlicense-text",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a "
        "compiled binary for any purpose commercial or non commercial and by any means",
    ),
    ("copyright-notice", "copyright <<opt>> c <<end>> <<var:4>> all rights reserved"),
]


class Automaton:
    """states[k]: word to next state; loops[k]: next state by any word; free[k]: next states by none."""

    def __init__(self, label: str, template: str) -> None:
        self.label, self.step, self.any, self.free = label, [], [], []
        now, opened = self._state(), []
        for part in re.findall(r"<<[^>]+>>|\S+", template):
            if part == "<<opt>>":
                opened.append(now)
            elif part == "<<end>>":
                self.free[opened.pop()].add(now)
            elif m := re.fullmatch(r"<<var:(\d+)>>", part):
                first = now
                passed = [first]
                for _ in range(int(m[1])):
                    new = self._state()
                    self.any[now] = new
                    now = new
                    passed.append(now)
                for k in passed[:-1]:
                    self.free[k].add(now)
            else:
                new = self._state()
                self.step[now] = (part, new)
                now = new
        self.last = now
        self.begin = self._closed({0})
        self.first_words = {self.step[k][0] for k in self.begin if self.step[k]}
        self.any_first = any(self.any[k] is not None for k in self.begin)
        self.mandatory = self._mandatory(template)

    def _state(self) -> int:
        self.step.append(None)
        self.any.append(None)
        self.free.append(set())
        return len(self.step) - 1

    @staticmethod
    def _mandatory(template: str) -> list[str]:
        depth, out = 0, []
        for part in re.findall(r"<<[^>]+>>|\S+", template):
            depth += (part == "<<opt>>") - (part == "<<end>>")
            if not part.startswith("<<") and not depth:
                out.append(part)
        return out

    def _closed(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for k in self.free[todo.pop()]:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        return frozenset(seen)

    def match(self, words: list[str], at: int) -> int | None:
        """Where the longest match that begins at a word ends, or None."""
        states, end = self.begin, None
        while True:
            if self.last in states:
                end = at
            if at == len(words) or not states:
                return end
            follow = {self.any[k] for k in states if self.any[k] is not None}
            follow |= {self.step[k][1] for k in states if self.step[k] and self.step[k][0] == words[at]}
            states, at = self._closed(follow), at + 1


def _hashes(words: list[str], hasher: Hasher) -> np.ndarray:
    return Words(pa.array([" ".join(words)], pa.string()), ALNUM, hasher).hash


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches array<struct<label, first, past>>).

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z, of whole texts; null counts as empty. Base
    places are where a phrase's words stand consecutively. labels adds those of accepted templates, score is the share
    of words of the document's base places and matches that matches cover, so 1 if templates explain all and 0 if there
    is none. Overlapping matches of one template count once, the first and longest. Rows are on their own; an empty table gives none."""
    automata = [Automaton(label, text) for label, text in templates]
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,first:long,past:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        wanted = [(_hashes(p.split(), hasher), label) for p, label in phrases.items()]
        # a template is tried on rows that hold one of its mandatory words, the longest one
        anchors = [(_hashes([max(a.mandatory, key=len)], hasher)[0], a) for a in automata]
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"), ALNUM, hasher)
                row = words.row_of_word()
                places: dict[int, list[tuple[int, int, str]]] = {}
                for phrase, label in wanted:
                    n = len(phrase)
                    if len(words.hash) < n:
                        continue
                    at = np.flatnonzero(np.all([words.hash[k : len(words.hash) - n + 1 + k] == phrase[k] for k in range(n)], axis=0) & (row[n - 1 :] == row[: len(row) - n + 1]))
                    for k in at.tolist():
                        r = int(row[k])
                        places.setdefault(r, []).append((k - int(words.first[r]), n, label))
                tried: dict[int, list[Automaton]] = {}
                for anchor, automaton in anchors:
                    for r in np.unique(row[words.hash == anchor]).tolist():
                        tried.setdefault(r, []).append(automaton)
                out = []
                for r in range(words.rows()):
                    base, found = places.get(r, []), []
                    if r in tried:
                        said = [words.data[s:e].tobytes().decode() for s, e in zip(words.start[words.first[r] : words.first[r + 1]], words.end[words.first[r] : words.first[r + 1]], strict=True)]
                        for automaton in tried[r]:
                            k = 0
                            while k < len(said):
                                end = automaton.match(said, k) if automaton.any_first or said[k] in automaton.first_words else None
                                if end is not None:
                                    found.append({"label": automaton.label, "first": k, "past": end})
                                k = max(k + 1, end or 0)
                    covered = {k for m in found for k in range(m["first"], m["past"])}
                    marked = covered | {k for at, n, _ in base for k in range(at, at + n)}
                    own = {label for *_, label in base}
                    out.append({
                        "n_words": int(words.first[r + 1] - words.first[r]), "n_base": len(base),
                        "first_word": min((b[0] for b in base), default=None), "last_word": max((b[0] for b in base), default=None),
                        "base_labels": ",".join(sorted(own)), "labels": ",".join(sorted(own | {m["label"] for m in found})),
                        "score": len(covered) / len(marked) if marked else 0.0, "matches": found,
                    })
                kinds = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("matches", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("past", pa.int64())])))])
                done = pa.RecordBatch.from_pylist(out, schema=kinds)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *done.columns], ["doc_id", *kinds.names])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
