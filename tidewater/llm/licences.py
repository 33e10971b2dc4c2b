"""Licence scans with a generalised suffix automaton.

All templates, as token sequences, make one automaton.  A text is streamed
through it once: after each token the state gives the longest run of tokens that
ends there and stands in some template (the matching statistics).  Maximal runs
of `MIN_RUN` tokens or more are chained, per template, into spans in the order of
the template with small gaps; a span that covers enough of its template gives
its label, and the largest part of a template that any chain covers is the text's score.
Base phrases are found in the same pass: a phrase ends where the state, or one that its
suffix links lead to, holds it.

Cost is linear in the tokens of a text, but for the few places where long runs
start; memory is one text and the automaton.  Nothing is shuffled.

Defined results: a null or empty text has no words, no places, empty labels and
score 0; doc_id is passed through, also null; repeated rows are scanned one by one; of
chains that a run continues equally well the first goes on; texts of any length are read
whole; further columns, whatever their names, are not looked at; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import pick, small_batches, table

#: The base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Licence notices as they are commonly given, by label.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "licensed under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("boost", "boost software license version 1 0"),
    ("mpl-2", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("wtfpl", "do what the fuck you want to public license"),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
    ("cc-by-nc-sa", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license"),
    ("mit", "spdx license identifier mit"),
    ("apache-2", "spdx license identifier apache 2 0"),
    ("bsd", "spdx license identifier bsd 2 clause"),
    ("bsd-3", "spdx license identifier bsd 3 clause"),
    ("gpl-2", "spdx license identifier gpl 2 0"),
    ("gpl-3", "spdx license identifier gpl 3 0"),
    ("mpl-2", "spdx license identifier mpl 2 0"),
    ("isc", "spdx license identifier isc"),
)
#: Tokens of a run that is worth chaining; tokens that a chain may skip; hundredths of a template that a span must cover.
MIN_RUN = 3
MAX_GAP = 4
MIN_COVER = 75

#: Bytes of a word: ASCII digits and letters, and all that isn't ASCII; A-Z become a-z, the rest parts words.
FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of token numbers."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for k, sequence in enumerate(sequences):
            last, path = 0, []
            for token in sequence:
                last = self._extend(last, token)
                path.append(last)
            for at, state in enumerate(path):
                self.ends[state].add((k, at))
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def _new(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.link) - 1

    def _clone(self, of: int, length: int, token: int, start: int) -> int:
        copy = self._new(length, self.link[of], dict(self.next[of]))
        self.link[of] = copy
        while start >= 0 and self.next[start].get(token) == of:
            self.next[start][token] = copy
            start = self.link[start]
        return copy

    def _extend(self, last: int, token: int) -> int:
        known = self.next[last].get(token)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._clone(known, self.length[last] + 1, token, last)
        made = self._new(self.length[last] + 1, 0, {})
        at = last
        while at >= 0 and token not in self.next[at]:
            self.next[at][token] = made
            at = self.link[at]
        if at >= 0:
            other = self.next[at][token]
            self.link[made] = other if self.length[other] == self.length[at] + 1 else self._clone(other, self.length[at] + 1, token, at)
        return made

    def step(self, state: int, length: int, token: int) -> tuple[int, int]:
        """State and length of the longest suffix of what was read that stands in some sequence."""
        edges = self.next
        while token not in edges[state]:
            state = self.link[state]
            if state < 0:
                return 0, 0
            length = self.length[state]
        return edges[state][token], length + 1


class Scanner:
    """The automaton of base phrases and templates, ready to stream texts."""

    def __init__(self, base=BASE, templates=TEMPLATES, min_run: int = MIN_RUN, max_gap: int = MAX_GAP, min_cover: int = MIN_COVER):
        self.base = [(words(p.encode()), label) for p, label in base]
        self.templates = [(words(t.encode()), label) for label, t in templates]
        self.min_run, self.max_gap, self.min_cover = min_run, max_gap, min_cover
        self.numbers: dict[bytes, int] = {}
        sequences = [[self.numbers.setdefault(w, len(self.numbers)) for w in tokens] for tokens, _ in [*self.templates, *self.base]]
        self.automaton = SuffixAutomaton(sequences)
        self.shortest = min((len(tokens) for tokens, _ in self.base), default=1)
        self.phrases: list[list[int]] = [[] for _ in self.automaton.link]
        for k, (tokens, _) in enumerate(self.base):
            state, length = 0, 0
            for w in tokens:
                state, length = self.automaton.step(state, length, self.numbers[w])
            self.phrases[state].append(k)

    def _phrases_at(self, state: int, length: int) -> Iterator[int]:
        while state > 0:
            for k in self.phrases[state]:
                if len(self.base[k][0]) <= length:
                    yield k
            state = self.automaton.link[state]
            length = min(length, self.automaton.length[state]) if state > 0 else 0

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], list[tuple[str, int, int, float]], float]:
        """Number of words; (phrase, first word) of all base places; (label, first word, last word, share covered) of all spans; the best share."""
        tokens = words(text)
        number = self.numbers.get
        places: list[tuple[int, int]] = []
        runs: list[tuple[int, int, int]] = []
        state = length = 0
        step = self.automaton.step
        for i, token in enumerate(map(number, tokens)):
            if token is None:
                if length >= self.min_run:
                    runs.append((i - length, i, state))
                state = length = 0
                continue
            was, before = state, length
            state, length = step(state, length, token)
            if before >= self.min_run and length <= before:
                runs.append((i - before, i, was))
            if length >= self.shortest:
                places += ((k, i + 1 - len(self.base[k][0])) for k in self._phrases_at(state, length))
        if length >= self.min_run:
            runs.append((len(tokens) - length, len(tokens), state))
        return len(tokens), places, *self._chain(runs)

    def _chain(self, runs: list[tuple[int, int, int]]) -> tuple[list[tuple[str, int, int, float]], float]:
        """Spans, and the largest share of a template that a chain covers: runs in order of the text, for each template joined to the open chain that they continue."""
        n = len(self.templates)
        open_chains: dict[int, list[list[int]]] = defaultdict(list)
        done: list[tuple[int, list[int]]] = []
        for start, end, state in runs:
            for template, last in sorted(self.automaton.ends[state]):
                if template >= n:
                    continue
                first = last + 1 - (end - start)
                kept, best = [], None
                for chain in open_chains[template]:
                    if start - chain[1] > self.max_gap:
                        done.append((template, chain))
                        continue
                    kept.append(chain)
                    if start >= chain[1] - 1 and 0 <= first - chain[2] <= self.max_gap and (best is None or chain[3] > best[3]):
                        best = chain
                own = [best[0], end, last + 1, best[3] + end - start] if best else [start, end, last + 1, end - start]
                if best:
                    kept.remove(best)
                open_chains[template] = [*kept, own]
        done += [(t, c) for t, chains in open_chains.items() for c in chains]
        spans, most = [], 0.0
        for template, (start, end, _, covered) in done:
            tokens, label = self.templates[template]
            most = max(most, min(1.0, covered / len(tokens)))
            if 100 * covered >= self.min_cover * len(tokens):
                spans.append((label, start, end - 1, min(1.0, covered / len(tokens))))
        return sorted(set(spans), key=lambda s: (s[1], s[2], s[0])), most


@lru_cache(maxsize=4)
def scanner_for(base=BASE, templates=TEMPLATES, min_run=MIN_RUN, max_gap=MAX_GAP, min_cover=MIN_COVER) -> Scanner:
    return Scanner(base, templates, min_run, max_gap, min_cover)


FOUND = "n_words long, base array<struct<label:string,word:long>>, spans array<struct<label:string,first:long,last:long,cover:double>>, score double"


def scan(docs: DataFrame, base=BASE, templates=TEMPLATES, **options) -> DataFrame:
    """(doc_id, n_words, base, spans, score): the base phrases' places, the template spans and the best cover of every text."""
    small_batches(docs.sparkSession)
    df = pick(docs, "doc_id", "text").select("doc_id", F.col("text").cast("binary").alias("text"))
    kind = df.schema["doc_id"].dataType.simpleString()
    inner = pa.struct([("label", pa.string()), ("word", pa.int64())])
    outer = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("cover", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = scanner_for(base, templates, *(options.get(k, v) for k, v in (("min_run", MIN_RUN), ("max_gap", MAX_GAP), ("min_cover", MIN_COVER))))
        labels = [label for _, label in scanner.base]
        for batch in batches:
            found = [scanner.scan(t or b"") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n for n, *_ in found], pa.int64()),
                    pa.array([[{"label": labels[k], "word": w} for k, w in sorted(p, key=lambda x: x[1])] for _, p, _, _ in found], pa.list_(inner)),
                    pa.array([[dict(zip(("label", "first", "last", "cover"), s, strict=True)) for s in spans] for _, _, spans, _ in found], pa.list_(outer)),
                    pa.array([s for *_, s in found], pa.float64()),
                ],
                names=["doc_id", "n_words", "base", "spans", "score"],
            )

    return df.mapInArrow(run, f"doc_id {kind}, {FOUND}")


def op8_license_scans(spark, sf_dir: str) -> DataFrame:
    df = scan(table(spark, sf_dir, "documents"))
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    starts = F.transform("base", lambda b: b["word"])
    return df.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(F.transform("base", lambda b: b["label"])).alias("base_labels"),
        joined(F.concat(F.transform("base", lambda b: b["label"]), F.transform("spans", lambda s: s["label"]))).alias("labels"),
        "score",
        F.col("spans").cast("string").alias("spans"),
    )
