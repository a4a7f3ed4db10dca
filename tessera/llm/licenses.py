"""License scans with a generalised suffix automaton of licence templates.

The automaton holds every factor of every template, by words. A file streams through it: at each word the
automaton gives the longest factor that ends there (the matching statistics). Maximal matches of MATCH
words or more are chained in template order into covered spans, each to any that ended at most GAP words before; a template that is covered enough, over a chain
without large gaps, gives its label. Words that no template has break every match, so only runs of
template words are streamed, which leaves the statistics of matches of MATCH words as they are.

Base labels are places where fixed phrases stand; they always stay.

Defined results: null and empty texts have no words, no labels and score 0; repeated rows are scanned
alike; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

# Fixed values of the contract.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Bytes that belong to words, with A-Z lowered; all others separate.
_WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

# Sentences of public licences by label, each a template of its own.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl", "it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl-3", "under the terms of the gnu affero general public license as published by the free software foundation either version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("apache-2", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form"),
    ("apache-2", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable except as stated in this section patent license to make have made use offer to sell sell import and otherwise transfer the work"),
    ("gpl-3", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-3", "you may convey verbatim copies of the program s source code as you receive it in any medium provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice"),
    ("gpl-2", "you may copy and distribute verbatim copies of the program s source code as you receive it in any medium provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice and disclaimer of warranty"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl-3", "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("mpl-2", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
    ("all-rights-reserved", "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means"),
)
MATCH = 4
COVERED = 0.75
GAP = 8


def words_of(text: bytes) -> list[bytes]:
    """Words of a text: runs of digits, letters and everything beyond ASCII, with A-Z lowered."""
    return text.translate(_WORD_BYTES).split()


class Automaton:
    """Generalised suffix automaton over word ids; ``ends`` lists (template, end) of each state's factors."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for number, seq in enumerate(sequences):
            last = 0
            for at, word in enumerate(seq):
                last = self._extend(last, word)
                self.ends[last].append((number, at + 1))
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[state]] = sorted(set(self.ends[self.link[state]]) | set(self.ends[state])) if self.link[state] > 0 else []

    def _add(self, length: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, parent: int, word: int, child: int) -> int:
        copy = self._add(self.length[parent] + 1, dict(self.next[child]), self.link[child])
        self.link[child] = copy
        while parent >= 0 and self.next[parent].get(word) == child:
            self.next[parent][word] = copy
            parent = self.link[parent]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            child = self.next[last][word]
            return child if self.length[child] == self.length[last] + 1 else self._split(last, word, child)
        new, parent = self._add(self.length[last] + 1, {}, 0), last
        while parent >= 0 and word not in self.next[parent]:
            self.next[parent][word] = new
            parent = self.link[parent]
        if parent >= 0:
            child = self.next[parent][word]
            self.link[new] = child if self.length[child] == self.length[parent] + 1 else self._split(parent, word, child)
        return new

    def stream(self, words: list[int]) -> list[tuple[int, int, int]]:
        """Maximal matches of MATCH words or more: (end in ``words``, length, state)."""
        found, state, n = [], 0, 0
        for i, w in enumerate(words):
            step = self.next[state].get(w)
            if step is None:
                if n >= MATCH:
                    found.append((i, n, state))
                while step is None and state > 0:
                    state = self.link[state]
                    n = self.length[state]
                    step = self.next[state].get(w)
                if step is None:
                    n = 0
                    continue
            state, n = step, n + 1
        if n >= MATCH:
            found.append((len(words), n, state))
        return found


class Scanner:
    """Scans batches of texts; built once per worker."""

    def __init__(self, templates=TEMPLATES):
        seqs = [t.encode().split() for _, t in templates]
        self.labels = [label for label, _ in templates]
        names = sorted({w for s in seqs for w in s} | {w for p, _ in BASE for w in p.encode().split()})
        self.id_of = {w: i + 1 for i, w in enumerate(names)}
        self.sequences = [[self.id_of[w] for w in s] for s in seqs]
        self.automaton = Automaton(self.sequences)
        self.base = [([self.id_of[w] for w in p.encode().split()], label) for p, label in BASE]

    def spans(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """Matches (start, end, state) of a text's word ids, 0 for words that no template has."""
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (ids != 0).astype(np.int8), [0]])))
        found = []
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            if b - a >= MATCH:
                found += [(a + end - n, a + end, state) for end, n, state in self.automaton.stream(ids[a:b].tolist())]
        return found

    def chain(self, found: list[tuple[int, int, int]]) -> dict[str, float]:
        """Label -> share of a template covered by the best chain of matches in template order."""
        by: dict[int, list[tuple[int, int, int, int]]] = {}
        for start, end, state in found:
            for number, at in self.automaton.ends[state]:
                by.setdefault(number, []).append((start, end, at - (end - start), at))
        best: dict[str, float] = {}
        for number, parts in by.items():
            size, top = len(self.sequences[number]), 0
            ended: dict[int, list[tuple[int, int]]] = {}  # end in the text -> (end in the template, words covered)
            for s, e, a, b in sorted(parts):
                before = 0
                for at in range(s - GAP, s + 1):
                    for b2, covered in ended.get(at, ()):
                        if a - GAP <= b2 <= a and covered > before:
                            before = covered
                ended.setdefault(e, []).append((b, before + e - s))
                top = max(top, before + e - s)
            label = self.labels[number]
            best[label] = max(best.get(label, 0.0), min(1.0, top / size))
        return best

    def scan(self, text: bytes) -> tuple:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score)."""
        words = words_of(text)
        get = self.id_of.get
        ids = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
        places, base = [], set()
        for phrase, label in self.base:
            n = len(ids) - len(phrase) + 1
            hit = ids[: max(0, n)] == phrase[0]
            if hit.any():
                for k in range(1, len(phrase)):
                    hit &= ids[k : k + n] == phrase[k]
                at = np.flatnonzero(hit)
                if len(at):
                    places.append(at)
                    base.add(label)
        share = self.chain(self.spans(ids))
        labels = base | {label for label, s in share.items() if s >= COVERED}
        score = 1.0 if base else max(share.values(), default=0.0)
        every = np.concatenate(places) if places else np.zeros(0, np.int64)
        first, last = (int(every.min()), int(every.max())) if len(every) else (None, None)
        return len(words), len(every), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), float(score)


_scanner: list[Scanner] = []
OUT = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"


def _run(batches):
    if not _scanner:
        _scanner.append(Scanner())
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
    names = [c.split()[0] for c in OUT.split(", ")]
    for batch in batches:
        for low in range(0, batch.num_rows, 2000):
            some = batch.slice(low, 2000)
            columns = zip(*map(_scanner[0].scan, utf8(some.column(1))), strict=True)
            yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_run, OUT)
