"""License scans by a generalised suffix automaton over the words of licence templates.

The automaton holds every run of words of every template. A file's words are streamed through it, which
gives for each place the longest run ending there that some template has (its matching statistics).
Runs that cannot be extended are matches; matches of one template that follow each other in order, with
small gaps, are chained into a span, and a span that covers enough of the template labels the file.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.common import UPPER, without

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(UPPER, UPPER.lower())

#: Phrases whose places are always counted, and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: The conditions that several licences share.
WARRANTY = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
BSD_HEAD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
BSD_TWO = "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
BSD_THIRD = "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
BSD_WARRANTY = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
#: Whole short licences, header notices and usual one-line notices, as words, and their labels.
TEMPLATES = {
    "apache-2.0": (
        "licensed under the apache license version 2 0", "you may not use this file except in compliance with the license",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "apache license version 2 0 january 2004 http www apache org licenses", "spdx license identifier apache 2 0",
    ),
    "mit": (
        "released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software " + WARRANTY,
        "mit license copyright c", "spdx license identifier mit",
    ),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "spdx license identifier isc"),
    "zlib": ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", "spdx license identifier zlib"),
    "bsl-1.0": ("boost software license version 1 0", "distributed under the boost software license version 1 0", "spdx license identifier bsl 1 0"),
    "gpl-3.0": (
        "this work is licensed under the gnu general public license version 3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu general public license version 3 29 june 2007", "spdx license identifier gpl 3 0",
    ),
    "gpl-2.0": (
        "this work is licensed under the gnu general public license version 2",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "gnu general public license version 2 june 1991", "spdx license identifier gpl 2 0",
    ),
    "lgpl": ("licensed under the gnu lesser general public license", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license version", "spdx license identifier lgpl"),
    "agpl-3.0": ("licensed under the gnu affero general public license version 3", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", "gnu affero general public license version 3 19 november 2007", "spdx license identifier agpl 3 0"),
    "bsd": ("licensed under the bsd license", "redistribution and use in source and binary forms with or without modification are permitted", "use of this source code is governed by a bsd style license that can be found in the license file"),
    "bsd-2-clause": (f"{BSD_HEAD} {BSD_TWO} {BSD_WARRANTY}", "bsd 2 clause license", "spdx license identifier bsd 2 clause"),
    "bsd-3-clause": (f"{BSD_HEAD} {BSD_TWO} {BSD_THIRD} {BSD_WARRANTY}", BSD_THIRD, "bsd 3 clause license", "spdx license identifier bsd 3 clause"),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license version 2 0", "spdx license identifier mpl 2 0"),
    "epl-2.0": ("this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse public license v 2 0", "spdx license identifier epl 2 0"),
    "cc-by-4.0": ("licensed under cc by 4 0", "creative commons attribution 4 0 international"),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0", "creative commons attribution sharealike 4 0 international"),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", "creative commons attribution noncommercial 4 0 international"),
    "cc0-1.0": ("dedicated to the public domain under cc0 1 0", "spdx license identifier cc0 1 0"),
    "unlicense": (
        "this is free and unencumbered software released into the public domain",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "spdx license identifier unlicense",
    ),
    "wtfpl": ("do what the fuck you want to public license",),
}
#: Shortest match, in words, that is chained; widest gap inside a chain; share of a template to be covered.
LEAST, GAP, COVER = 3, 3, 0.8


class Automaton:
    """Suffix automaton of several word sequences; a state knows the first and the last place in each where its runs end."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, tuple[int, int]]] = [{}]
        for t, words in enumerate(sequences):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, w)
                self.ends[last][t] = (self.ends[last].get(t, (i, i))[0], i)
        for v in sorted(range(1, len(self.link)), key=lambda v: -self.length[v]):
            above = self.ends[self.link[v]]
            for t, (first, last) in self.ends[v].items():
                had = above.get(t, (first, last))
                above[t] = min(first, had[0]), max(last, had[1])

    def _new(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.ends.append({})
        return len(self.link) - 1

    def _split(self, p: int, w: int) -> int:
        """The state for the longest run of ``p`` and ``w``, made apart from longer runs if need be."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = twin
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w)
        new = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        self.link[new] = self._split(p, w) if p >= 0 else 0
        return new

    def matches(self, words: list[int], offset: int = 0) -> list[tuple[int, int, int]]:
        """(start, stop, state) of runs of ``LEAST`` words or more that neither end can be extended."""
        return [(start, stop, state) for start, stop, state, of in self.runs(words, offset) if of is None]

    def runs(self, words: list[int], offset: int = 0) -> list[tuple[int, int, int, list[int] | None]]:
        """The matches, with None, and where a longer run goes on in some templates alone, those it ends in."""
        found, state, size = [], 0, 0
        for i, w in enumerate(words):
            before = (state, size)
            while state and w not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if w in self.next[state]:
                state, size = self.next[state][w], size + 1
            if before[1] >= LEAST:
                if size <= before[1]:
                    found.append((offset + i - before[1], offset + i, before[0], None))
                elif len(self.ends[state]) < len(self.ends[before[0]]):
                    found.append((offset + i - before[1], offset + i, before[0], [t for t in self.ends[before[0]] if t not in self.ends[state]]))
        if size >= LEAST:
            found.append((offset + len(words) - size, offset + len(words), state, None))
        return found


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, ...]], phrases: dict[str, str]):
        texts = [(label, text.split()) for label, several in templates.items() for text in several]
        self.labels, self.sizes = [label for label, _ in texts], [len(w) for _, w in texts]
        self.ids: dict[str, int] = {}
        for words in [*(w for _, w in texts), *(p.split() for p in phrases)]:
            for w in words:
                self.ids.setdefault(w, len(self.ids))
        self.automaton = Automaton([[self.ids[w] for w in words] for _, words in texts])
        self.phrases = [([self.ids[w] for w in p.split()], label) for p, label in phrases.items()]
        self.starts: dict[int, list] = {}
        for p, label in self.phrases:
            self.starts.setdefault(p[0], []).append((p, label))

    def scan(self, text: str | None) -> dict:
        words = WORD.findall((text or "").translate(LOWER))
        codes = np.fromiter(map(self.ids.get, words, (-1 for _ in words)), dtype=np.int32, count=len(words))
        known = np.flatnonzero(codes >= 0)
        places: list[int] = []
        base: set[str] = set()
        spans: list[tuple] = []
        # Runs of words that templates have; nothing else can hold a phrase or a match.
        for run in np.split(known, np.flatnonzero(np.diff(known) > 1) + 1) if len(known) else ():
            if len(run) < 2:
                continue
            part, at = codes[run[0] : run[-1] + 1].tolist(), int(run[0])
            for i, w in enumerate(part):
                for phrase, label in self.starts.get(w, ()):
                    if part[i : i + len(phrase)] == phrase:
                        places.append(at + i)
                        base.add(label)
            if len(part) >= LEAST:
                spans += self.automaton.runs(part, at)
        chains = self.chain(spans)
        labels = {self.labels[t] for t, _, _, share in chains if share >= COVER}
        best = max((share for *_, share in chains), default=0.0)
        return {
            "n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | labels)), "score": 1.0 if places else min(1.0, best),
            "spans": [(self.labels[t], start, stop, share) for t, start, stop, share in chains if share >= COVER],
        }

    def chain(self, matches) -> list[tuple[int, int, int, float]]:
        """(template, start, stop, share of the template covered) of the chains of matches."""
        open_: dict[int, tuple[int, int, int, int]] = {}
        done: list[tuple[int, int, int, float]] = []

        def close(t):
            start, stop, _, covered = open_.pop(t)
            done.append((t, start, stop, covered / self.sizes[t]))

        for start, stop, state, of in matches:
            ends = self.automaton.ends[state]
            for t in sorted(ends if of is None else of):
                (end, last), covered = ends[t], stop - start
                if t in open_:
                    s, e, reached, had = open_[t]
                    skip = max(0, e - start)
                    # The first place that goes on from what the chain has reached, as far as first and last tell.
                    end = end if end - covered + 1 + skip > reached else last
                    if start - e <= GAP and end - covered + 1 + skip > reached and skip < covered:
                        open_[t] = (s, stop, end, had + covered - skip)
                        continue
                    # The longer of two that do not go together stays open.
                    if start - e <= GAP and had >= covered:
                        continue
                    close(t)
                open_[t] = (start, stop, end, covered)
        for t in list(open_):
            close(t)
        return done


@lru_cache(1)
def scanner() -> Scanner:
    return Scanner(TEMPLATES, PHRASES)


KINDS = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("share", pa.float64())]))}
DDL = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,stop:long,share:double>>"


def scan_licences(df: DataFrame, *, text: str = "text") -> DataFrame:
    """``df`` with n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    A null or empty text has no words, no labels and score 0. ``score`` is 1 where a phrase stands, else the
    largest share of a template that one chain covers. Whole texts are read, whatever their length; repeated
    rows and nulls elsewhere pass through, and columns named as an output are replaced.
    """
    kept = without(df, KINDS)
    source = df.select(*(df[f"`{c}`"] for c in kept), df[f"`{text}`"].cast("string").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1]), DDL])

    def run(batches):
        for batch in batches:
            found = [scanner().scan(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            columns = [pa.array([[dict(zip(("label", "start", "stop", "share"), s)) for s in f[k]] if k == "spans" else f[k] for f in found], kind) for k, kind in KINDS.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], *KINDS])

    return source.mapInArrow(run, schema)
