"""License scans: phrases, and license texts matched through template automata.

A template is wording with markup: ``[[...]]`` is optional, ``{{name:max}}`` is replaceable by up
to ``max`` words, everything else is mandatory.  Each template is compiled into an automaton over
word ids (states are positions, optional regions are empty moves, replaceable regions loop a
bounded number of times), and a text has the template's label where all mandatory words occur
exactly, in order.  The automaton starts only at places where its first mandatory words stand, so
text without license wording costs one dictionary look-up per word.

Templates are whole license texts up to the end of their terms (``TEXTS``) and short notices by which
a work names its license (``NOTICES``); an excerpt of a license, or one with altered clauses, is neither.
Base labels come from plain phrases.  ``score`` is 1 where a whole text or notice matched, 0.5 where
only phrases stand, 0 for neither.

Edge rows: null and empty texts have no words, no labels and score 0; repeated rows are scanned
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelflight.llm.common import map_batches, words

# The phrases that decide base labels.
PHRASES = {
    "gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit",
}
_NUMBER = "[[{{number:1}}]] "
_PROVIDED = "this software is provided by {{holder:16}} as is and any express or implied warranties including but not limited to the " \
    "implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{holder:16}} be " \
    "liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement " \
    "of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of " \
    "liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of " \
    "this software even if advised of the possibility of such damage"
_BSD = [
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
    "conditions are met " + _NUMBER + "redistributions of source code must retain the above copyright notice this list of conditions "
    "and the following disclaimer",
    _NUMBER + "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
    "disclaimer in the documentation and or other materials provided with the distribution",
    _NUMBER + "all advertising materials mentioning features or use of this software must display the following acknowledgement "
    "this product includes software developed by {{holder:24}}",
    _NUMBER + "neither the name of {{holder:16}} nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission",
]


def _text(name: str, end: str) -> str:
    """The wording of a license up to the end of its terms."""
    whole = (Path(__file__).parent / "license_texts" / f"{name}.txt").read_text("utf-8")
    return b" ".join(words(whole[: whole.index(end)] if end else whole)).decode()


_END = "END OF TERMS AND CONDITIONS"
# Whole license texts, with markup for what may vary.
TEXTS = {
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to "
        "permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice "
        "and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the "
        "software the software is provided as is without warranty of any kind express or implied including but not limited to the "
        "warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {{holder:16}} be liable "
        "for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in "
        "connection with the software or the use or other dealings in the software",
    ],
    "isc": [
        "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as "
        "is and {{holder:16}} disclaims all warranties with regard to this software including all implied warranties of "
        "merchantability and fitness in no event shall {{holder:16}} be liable for any special direct indirect or consequential damages "
        "or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other "
        "tortious action arising out of or in connection with the use or performance of this software",
    ],
    "bsd-2-clause": [" ".join([*_BSD[:2], _PROVIDED])],
    "bsd-3-clause": [" ".join([*_BSD[:2], _BSD[3], _PROVIDED])],
    "bsd-4-clause": [" ".join([*_BSD, _PROVIDED])],
    "apache": [_text("Apache-2.0", _END)],
    "gpl": [_text("GPL-2", _END), _text("GPL-3", _END)],
    "lgpl": [_text("LGPL-2.1", _END), _text("LGPL-3", "")],
    "mpl": [_text("MPL-2.0", "Exhibit A - ")],
}
# Short notices by which a work names its license; excerpts of a license are none.
NOTICES = {
    "mit": [
        "[[{{subject:6}}]] released under the [[terms of the]] mit license",
        "licensed under the [[terms of the]] mit license",
    ],
    "apache": [
        "licensed under the apache license version 2 0 [[the license]]",
        "[[this {{work:3}} is]] licensed under the apache license [[version {{version:2}}]]",
    ],
    "gpl": [
        "is free software you can redistribute it and or modify it under the terms of the gnu general public license "
        "as published by the free software foundation either version {{version:2}} of the license",
        "licensed under the [[terms of the]] gnu general public license [[version {{version:2}}]]",
    ],
    "lgpl": ["under the terms of the gnu lesser general public license"],
    "mpl": ["subject to the terms of the mozilla public license v 2 0"],
    "cc-by": [
        "licensed under a creative commons attribution {{version:3}} [[international]] license",
        "licensed under cc by [[{{version:2}}]]",
    ],
    "proprietary": ["copyright [[c]] {{holder:8}} all rights reserved"],
}
TEMPLATES = {k: TEXTS.get(k, []) + NOTICES.get(k, []) for k in TEXTS | NOTICES}
_PART = re.compile(r"\[\[|\]\]|\{\{\w+:(\d+)\}\}|[^\[\]{}\s]+")


class Automaton:
    """Arcs of one template: per state the words that lead on, the empty moves, the gaps."""

    def __init__(self, template: str) -> None:
        self.step: list[dict[bytes, int]] = [{}]
        self.skip: dict[int, list[int]] = {}
        opened: list[int] = []
        for part in _PART.finditer(template):
            state = len(self.step) - 1
            if part[0] == "[[":
                opened.append(state)
            elif part[0] == "]]":
                self.skip.setdefault(opened.pop(), []).append(state)
            elif part[1]:
                for _ in range(int(part[1])):  # any word, and out at any time
                    self.step[-1] = {b"*": len(self.step)}
                    self.step.append({})
                last = len(self.step) - 1
                for at in range(state, last):
                    self.skip.setdefault(at, []).append(last)
            else:
                self.step[-1] = {part[0].encode(): len(self.step)}
                self.step.append({})
        self.end = len(self.step) - 1
        self.first = {w for s in self._closure({0}) for w in self.step[s] if w != b"*"}

    def _closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for on in self.skip.get(todo.pop(), ()):
                if on not in states:
                    states.add(on)
                    todo.append(on)
        return states

    def accepts(self, text: Sequence[bytes], start: int) -> bool:
        """Whether a run from ``start`` reaches the end; active states never exceed the template."""
        states = self._closure({0})
        for at in range(start, len(text)):
            if self.end in states:
                return True
            moved = {self.step[s][w] for s in states for w in (text[at], b"*") if w in self.step[s]}
            if not moved:
                return False
            states = self._closure(moved)
        return self.end in states


class Scanner:
    """All phrases and templates, found through the words they can begin with."""

    def __init__(self, phrases: dict[str, str] = PHRASES, templates: dict[str, list[str]] = TEMPLATES) -> None:
        self.phrases: dict[bytes, list[tuple[list[bytes], str]]] = {}
        for phrase, label in phrases.items():
            wording = phrase.encode().split()
            self.phrases.setdefault(wording[0], []).append((wording, label))
        self.automata: dict[bytes, list[tuple[Automaton, str]]] = {}
        for label, wordings in templates.items():
            for wording in wordings:
                automaton = Automaton(wording)
                for word in automaton.first:
                    self.automata.setdefault(word, []).append((automaton, label))
        self.starts = frozenset(self.phrases) | frozenset(self.automata)

    def scan(self, text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
        """n_words, n_base, first and last start, base labels, labels, score."""
        found = words(text)
        starts: list[int] = []
        base: set[str] = set()
        more: set[str] = set()
        if not self.starts.isdisjoint(found):
            for at in [i for i, w in enumerate(found) if w in self.starts]:
                for wording, label in self.phrases.get(found[at], ()):
                    if found[at : at + len(wording)] == wording:
                        starts.append(at)
                        base.add(label)
                for automaton, label in self.automata.get(found[at], ()):
                    if label not in more and automaton.accepts(found, at):
                        more.add(label)
        first, last = (min(starts), max(starts)) if starts else (None, None)
        score = 1.0 if more else 0.5 if base else 0.0
        return len(found), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(base | more)), score


_SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
           "labels string, score double")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row."""
    scanner = Scanner()
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [scanner.scan(text) for text in batch.column(1).to_pylist()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], [f.split()[0] for f in _SCHEMA.split(", ")])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, _SCHEMA)
